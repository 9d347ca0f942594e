"""SentencePiece encoding and decoding as the shortest path through a weighted finite-state transducer.

Machines are compiled from a model file:

* the normaliser N: a trie over characters whose final states write what replaces them (the longest rule applies,
  other characters are copied), a dummy prefix, and white space written as a mark;
* the lexicon L: a trie over characters whose final states write piece ids;
* the fallback F: a character that no piece spells is spelled by the byte pieces of its UTF-8 instead, or by the
  unknown piece where the model has none;
* for BPE models the pair machine P over piece ids, which holds the model's order of merges. Its states are the
  last pieces written; its arc from a to b weighs 0 if merging the spelling of a and b gives a and b again, else
  infinity.

For unigram models the path of least weight through input * N * (L + F) in the tropical semiring, with minus its log
probability for each piece, is the library's segmentation. Sums are of 32 bits as there; as parts of a text are summed
by themselves, paths that differ by less than the rounding of a long text's sum may be told apart otherwise.

For BPE models, a sequence of pieces is what merging by rank makes of its text if and only if all its neighbours are
such pairs: no merge ever crosses the border between two final pieces, so what happens inside two neighbours does not
depend on the rest, and if all pairs hold, the first merge across a border would already have crossed it in that pair
alone. So the path of least weight through input * N * (L + F) * P, with 1 for each piece, is the library's own.

The composition is done lazily, state by state. If no piece has a mark after another character, the path splits at
each mark that follows one; the parts' paths are kept in a bounded worker cache.
"""

from __future__ import annotations

import os
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodefinder.llm.common import held, map_text

MARK = "▁"
CHUNK = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
#: Parts of a generation of a worker's cache, and a quarter of its pairs. It changes no result.
CACHE_SIZE = 300_000
#: Above any state of the pair machine: piece ids, then characters without a piece.
SIDE = 1 << 32


#: Fixed values of the compiled normaliser's trie: bits of a 32-bit unit.
LEAF, LABEL, VALUE, FAR = 1 << 8, 1 << 31 | 0xFF, (1 << 31) - 1, 1 << 9
#: Fixed value of unigram models: how much less likely than the least likely piece an unknown character is, as a logarithm.
UNKNOWN_PENALTY = np.float32(10)


def compiled(entries: dict) -> dict:
    """A trie: states are dicts by character; the entry '' of a final state is what it writes."""
    root: dict = {}
    for text, output in entries.items():
        state = root
        for c in text:
            state = state.setdefault(c, {})
        state[""] = output
    return root


def rules_of(charsmap: bytes) -> dict[str, str]:
    """Replacements by text from a compiled normaliser: u32 size, a double-array trie over UTF-8, texts that end in zero.

    All states of one depth are followed at once. A key's value is where its replacement begins in the texts.
    """
    if not charsmap:
        return {}
    (size,) = struct.unpack_from("<I", charsmap)
    units, texts = np.frombuffer(charsmap, "<u4", size // 4, 4).astype(np.int64), charsmap[4 + size :]
    children = lambda unit: (unit >> 10) << ((unit & FAR) >> 6)
    letters, keys, states, rules = np.arange(1, 256), [b""], children(units[:1]), {}
    while keys:
        at = states[:, None] ^ letters
        state, letter = np.nonzero(units[np.minimum(at, len(units) - 1)] & LABEL == np.where(at < len(units), letters, -1))
        found = at[state, letter]
        keys = [keys[i] + bytes([c + 1]) for i, c in zip(state.tolist(), letter.tolist(), strict=True)]
        states = found ^ children(units[found])
        for i in np.flatnonzero(units[found] & LEAF):
            begin = int(units[states[i]] & VALUE)
            rules[keys[i].decode()] = texts[begin : texts.index(b"\0", begin)].decode()
    return rules


class Normaliser:
    """The normaliser's machine; it has one path for each text."""

    def __init__(self, spec) -> None:
        if not spec.escape_whitespaces:
            raise ValueError("white space must be written as marks")
        self.trie = compiled(rules_of(spec.precompiled_charsmap))
        self.starts = re.compile(f"[{''.join(map(re.escape, self.trie))}]") if self.trie else None
        self.prefix, self.squeezes = MARK if spec.add_dummy_prefix else "", spec.remove_extra_whitespaces

    def rewritten(self, text: str) -> str:
        """text after its rules: at each place that the first character of one is at, the longest that fits."""
        out, at = [], 0
        while begin := self.starts.search(text, at):
            begin = begin.start()
            out.append(text[at:begin])
            new, at, state, j = text[begin], begin + 1, self.trie, begin
            while j < len(text) and (state := state.get(text[j])) is not None:
                j += 1
                if "" in state:
                    new, at = state[""], j
            out.append(new)
        return "".join([*out, text[at:]])

    def __call__(self, text: str) -> str:
        if self.starts:
            text = self.rewritten(text)
        if not self.squeezes:
            return self.prefix + text.replace(" ", MARK)
        return (self.prefix + re.sub(" {2,}", " ", text).lstrip(" ").replace(" ", MARK)).rstrip(MARK)


class Transducer:
    """Encodes and decodes as the SentencePiece library does, for BPE and unigram models without user-defined or unused pieces."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(lib.get_piece_size())
        if spec.trainer_spec.model_type not in (1, 2) or spec.trainer_spec.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in spec.pieces):
            raise ValueError("only BPE and unigram models with marks before words and without user-defined or unused pieces are supported")
        self.normaliser = Normaliser(spec.normalizer_spec)
        self.unknown = lib.unk_id()
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) for i in ids]
        names = [lib.id_to_piece(i) for i in ids]
        self.bytes = {int(names[i][3:5], 16): i for i in ids if lib.is_byte(i)}
        self.lexicon = {names[i]: i for i in ids if not special[i]}
        self.score = {names[i]: lib.get_score(i) for i in ids if not special[i]}
        self.trie = compiled(self.lexicon)
        self.spelling = [bytes([int(names[i][3:5], 16)]) if lib.is_byte(i) else b"" if lib.is_control(i) else names[i].replace(MARK, " ").encode() for i in ids]
        self.spelling[self.unknown] = spec.trainer_spec.unk_surface.encode()
        self.marked = {i for i in ids if not special[i] and names[i].startswith(MARK)}
        self.splits = not any(re.search(f"[^{MARK}]{MARK}", p) for p in self.lexicon)
        self.names = names
        self.shortest = self.likeliest if spec.trainer_spec.model_type == 1 else self.merged
        self.weights = {i: -np.float32(self.score[p]) for p, i in self.lexicon.items()}
        self.unknown_weight = max(self.weights.values(), default=np.float32(0)) + UNKNOWN_PENALTY
        self.pairs: dict[int, bool] = {}
        self.known = Paths(self)

    def merge(self, text: str) -> list[str]:
        """What merging by score, left first, makes of a short text."""
        parts, score = list(text), self.score
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def stands(self, left: int, right: int) -> bool:
        """Whether the pair machine has an arc of finite weight from left to right; left may be its first state, -1."""
        if len(self.pairs) >= 4 * CACHE_SIZE:
            self.pairs.clear()
        parts = [self.text_of(left), self.text_of(right)] if left >= 0 else [self.text_of(right)]
        found = self.pairs[left * SIDE + right] = self.merge("".join(parts)) == parts
        return found

    def text_of(self, i: int) -> str:
        return self.names[i] if i < len(self.names) else chr(i - len(self.names))

    def merged(self, text: str) -> list[int]:
        """Ids along the path of least weight through the composed machine of a BPE model for a normalised text.

        Relaxes arcs position by position. As the pieces up to a position must be what merging makes of the
        characters up to it, at most one state of each position is reached with finite weight.
        """
        trie, pairs, n, top = self.trie, self.pairs, len(text), len(self.names)
        weight = [0.0] + [float("inf")] * n
        last, before = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            if weight[i] == float("inf"):
                continue
            here, cost, node, j = last[i] * SIDE, weight[i] + 1, trie, i
            if text[i] not in trie or "" not in trie[text[i]]:
                piece = top + ord(text[i])  # an arc of the fallback; the character has a state of its own
                found = pairs.get(here + piece)
                if (self.stands(last[i], piece) if found is None else found) and cost < weight[i + 1]:
                    weight[i + 1], last[i + 1], before[i + 1] = cost, piece, i
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                piece = node.get("")
                if piece is not None and cost < weight[j]:
                    found = pairs.get(here + piece)
                    if self.stands(last[i], piece) if found is None else found:
                        weight[j], last[j], before[j] = cost, piece, i
        if weight[n] == float("inf"):
            raise ValueError("no path: the model's pieces do not cover the text")
        return self.written(last, before)

    def likeliest(self, text: str) -> list[int]:
        """Ids along the path of least weight through the composed machine of a unigram model for a normalised text.

        Of paths of equal weight that with the longer last piece wins. A character's arc through the fallback exists
        only where no piece spells it, so each position is reached.
        """
        trie, weights, n, top = self.trie, self.weights, len(text), len(self.names)
        weight = [np.float32(0)] + [np.float32("inf")] * n
        last, before = [-1] * (n + 1), [0] * (n + 1)
        for i in range(n):
            node, j = trie, i
            if text[i] not in trie or "" not in trie[text[i]]:
                cost = weight[i] + self.unknown_weight
                if cost < weight[i + 1]:
                    weight[i + 1], last[i + 1], before[i + 1] = cost, top + ord(text[i]), i
            while j < n and (node := node.get(text[j])) is not None:
                j += 1
                piece = node.get("")
                if piece is not None and (cost := weight[i] + weights[piece]) < weight[j]:
                    weight[j], last[j], before[j] = cost, piece, i
        return self.written(last, before)

    def written(self, last: list[int], before: list[int]) -> list[int]:
        """What the arcs on the path to the last position write, first to last."""
        path, end, top = [], len(last) - 1, len(self.names)
        while end > 0:
            path.append(last[end])
            end = before[end]
        return [i for p in reversed(path) for i in ([p] if p < top else self.fallback(chr(p - top)))]

    def fallback(self, char: str) -> list[int]:
        """What the fallback's arc of a character writes."""
        return [self.bytes[b] for b in char.encode()] if self.bytes else [self.unknown]

    def encode(self, text: str | None) -> bytes:
        """Piece ids as little-endian unsigned 32-bit integers; where there are no byte pieces, unknown characters in a row are one."""
        if not text:
            return b""
        text = self.normaliser(text)
        ids = b"".join(map(self.known.__getitem__, CHUNK.findall(text) if self.splits else [text] if text else []))
        if self.bytes:
            return ids
        ids = np.frombuffer(ids, dtype="<u4")
        unknown = ids == self.unknown
        return ids[~(unknown & np.append(False, unknown)[: len(ids)])].tobytes()

    def decode(self, ids: bytes) -> str:
        """The text that ids spell: marks become spaces, bytes become characters, the dummy prefix goes.

        Where the normaliser squeezes white space, all marks before the first other character go.
        """
        ids = np.frombuffer(ids, dtype="<u4").tolist()
        spelled = list(map(self.spelling.__getitem__, ids))
        if self.normaliser.prefix or self.normaliser.squeezes:
            for k, i in enumerate(ids):
                if i in self.marked:
                    spelled[k] = spelled[k][1:]
                    if not self.normaliser.squeezes:
                        break
                if spelled[k]:
                    break
        return b"".join(spelled).decode(errors="replace")


class Paths(dict):
    """Shortest path of each part of a text, kept in two generations of CACHE_SIZE parts.

    Where the young one is full it becomes the old one, from which parts that come up again return.
    """

    def __init__(self, machine: Transducer) -> None:
        super().__init__()
        self.machine, self.old = machine, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.old.get(part)
        if ids is None:
            ids = np.array(self.machine.shortest(part), dtype="<u4").tobytes()
        if len(part) <= 64:
            if len(self) >= CACHE_SIZE:
                self.old = dict(self)
                self.clear()
            self[part] = ids
        return ids


def machine_of(model: str) -> Transducer:
    """This worker's machine of a model: the name of a public one, or a path that every worker can read."""
    return held(("wfst", model), lambda: Transducer(model if os.path.isabs(model) else public_tokenizers.path(model)))


def encode(docs: DataFrame, keep: list[str], text_col: str = "text", model: str = "piece_bpe_32k.model", ids_col: str = "ids", decoded_col: str | None = "decoded") -> DataFrame:
    """The kept columns, the ids of each whole text (array of int) and, unless decoded_col is None, the text decoded from them.

    A null text has no ids and decodes to ''. With the model as given, decoding gives the text back, but for marks
    (U+2581) in it, which come back as spaces; other models give the normalised text, without unknown characters.
    """
    fields = [(ids_col, T.ArrayType(T.IntegerType()))] + [(decoded_col, T.StringType())] * bool(decoded_col)

    def start():
        machine = machine_of(model)

        def compute(texts):
            made = [machine.encode(x) for x in texts]
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in made]
            return [ids, [machine.decode(x) for x in made]][: len(fields)]

        return compute

    return map_text(docs, text_col, keep, fields, start)


def encode_digest(docs: DataFrame, keep: list[str], text_col: str = "text", model: str = "piece_bpe_32k.model") -> DataFrame:
    """The kept columns, n_pieces, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), round_trip.

    round_trip: whether decoding the ids gives the text back, marks read as spaces. Null texts: 0 pieces, true.
    """

    def start():
        machine = machine_of(model)

        def compute(texts):
            made = [machine.encode(x) for x in texts]
            same = [machine.decode(m) == (x or "").replace(MARK, " ") for m, x in zip(made, texts, strict=True)]
            return [[len(m) // 4 for m in made], [zlib.crc32(m) for m in made], same]

        return compute

    return map_text(docs, text_col, keep, [("n_pieces", T.LongType()), ("ids_crc32", T.LongType()), ("round_trip", T.BooleanType())], start)

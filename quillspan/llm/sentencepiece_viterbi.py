"""SentencePiece ids by a streaming Viterbi search, and texts from ids.

The search goes over the text once. Each boundary keeps one backpointer; positions older than
the longest piece can't be reached by a new piece, and whenever all surviving backpointer paths converge on one
boundary the ids before it are committed and forgotten, so that memory holds a window only.

What survives at a boundary depends on the vocabulary. Unigram: the path with the highest sum of scores,
ties to the longer last piece. BPE: the sum of scores is not what merging maximises, so an arc survives
if merging its piece with the piece before leaves both as they are; exactly one does at each boundary, and the path is the one that merging gives.

Two characters that stand side by side in no piece are a boundary on which all paths converge, and so is the start of a
word in vocabularies whose pieces hold no space but in front. Words that fit in the window whole are searched at once and remembered,
as they repeat; of others, the stretches between such places.

A character that no piece covers costs the lowest score less 10 and becomes byte pieces (the unknown id
without those). A literal U+2581 is written as bytes, so that it doesn't come back as a space.

Defined results: null and empty texts have no ids and decode to an empty text; an empty table gives an empty
result; ids may be null or repeat; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspan.llm.common import by_batch

MARK = "\u2581"


class Viterbi:
    def __init__(self, model: str, kind: str | None = None, keep: int = 250_000):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        special = {i for i in range(size) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)}
        self.texts = [sp.id_to_piece(i) for i in range(size)]
        self.pieces = {self.texts[i]: i for i in range(size) if i not in special}
        self.scores = {self.texts[i]: sp.get_score(i) for i in self.pieces.values()}
        self.bytes = {int(self.texts[i][3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.unknown = sp.unk_id()
        #: what each id stands for in a text
        self.raw = [
            bytes([self.byte_of[i]]) if i in self.byte_of else b" \xe2\x81\x87 " if i == self.unknown else b"" if i in special else t.replace(MARK, " ").encode()
            for i, t in enumerate(self.texts)
        ]
        #: BPE scores are ranks: whole numbers
        self.kind = kind or ("bpe" if all(s == int(s) for s in self.scores.values()) else "unigram")
        self.longest = max(map(len, self.pieces))
        self.penalty = min(self.scores.values()) - 10.0
        ends: dict[str, set[int]] = {}
        for piece in self.pieces:
            ends.setdefault(piece[0], set()).add(len(piece))
        self.lengths = {c: sorted(n, reverse=True) for c, n in ends.items()}
        self.beside = {piece[k : k + 2] for piece in self.pieces for k in range(len(piece) - 1)}
        self.word_breaks = not any(MARK in p.lstrip(MARK) for p in self.pieces)
        #: numbers of what may stand before a piece: ids, characters that no piece covers, and nothing
        self.size, self.nothing = size, size + 0x110000
        #: the pieces letter by letter; the key "" holds a piece's id
        self.trie: dict = {}
        for piece, i in self.pieces.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self.memory: dict[str, list[int]] = {}
        self.stays: dict[int, bool] = {}
        self.keep = keep

    def merged(self, text: str) -> list[str]:
        """``text`` merged pair by pair, best score first, leftmost on ties."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = float("-inf"), -1
            for k in range(len(parts) - 1):
                s = scores.get(parts[k] + parts[k + 1])
                if s is not None and s > best:
                    best, at = s, k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def fits(self, before: int, piece: int) -> bool:
        """Whether merging leaves ``piece`` after ``before`` as it is."""
        known = self.stays.get(before * self.size + piece)
        if known is None:
            if len(self.stays) > 2 * self.keep:
                self.stays.clear()
            first = "" if before == self.nothing else self.texts[before] if before < self.size else chr(before - self.size)
            known = self.merged(first + self.texts[piece]) == ([first] if first else []) + [self.texts[piece]]
            self.stays[before * self.size + piece] = known
        return known

    def window(self, text: str) -> list[int]:
        """What ``stream`` gives for a BPE text that fits in the window whole: one surviving arc for each boundary."""
        n, size, stays = len(text), self.size, self.stays
        last: list[int | None] = [self.nothing, *[None] * n]
        back = [0] * (n + 1)
        for at, c in enumerate(text):
            here = last[at] * size
            node = self.trie
            for end in range(at + 1, n + 1):
                node = node.get(text[end - 1])
                if node is None:
                    break
                if "" in node and last[end] is None:
                    i = node[""]
                    known = stays.get(here + i)
                    if known or (known is None and self.fits(last[at], i)):
                        last[end], back[end] = i, at
            if last[at + 1] is None:  # no piece covers the character
                last[at + 1], back[at + 1] = size + ord(c), at
        out: list[int] = []
        while n:
            i = last[n]
            out += [i] if i < size else self.spelled(text[n - 1])[::-1]
            n = back[n]
        out.reverse()
        return out

    def spelled(self, char: str) -> list[int]:
        if len(self.bytes) == 256:
            return [self.bytes[b] for b in char.encode("utf-8", "surrogatepass")]
        return [self.unknown]

    def stream(self, chars):
        """Yield ids for an iterable of characters, holding little more than a window of the longest piece."""
        width, bpe, pieces, scores = self.longest, self.kind == "bpe", self.pieces, self.scores
        text, base = "", 0  # the window, and the position of its first character
        best, back = {0: self.nothing if bpe else 0.0}, {}  # by boundary: number of the last piece, or score; (start, piece)
        feed, done, at = iter(chars), False, 0
        while True:
            while not done and len(text) - (at - base) < width:
                c = next(feed, None)
                if c is None:
                    done = True
                else:
                    text += c
            if at - base == len(text):
                break
            here, k = best.pop(at), at - base
            c, room = text[k], len(text) - (at - base)
            for n in self.lengths.get(c, ()):
                if n <= room and (piece := text[k : k + n]) in pieces:
                    if bpe:
                        if at + n not in best and self.fits(here, pieces[piece]):
                            best[at + n], back[at + n] = pieces[piece], (at, piece)
                    elif (s := here + scores[piece]) > best.get(at + n, float("-inf")):
                        best[at + n], back[at + n] = s, (at, piece)
            if bpe:
                if at + 1 not in best:  # no piece covers the character
                    best[at + 1], back[at + 1] = self.size + ord(c), (at, c)
            elif here + self.penalty > best.get(at + 1, float("-inf")):
                best[at + 1], back[at + 1] = here + self.penalty, (at, c)
            at += 1
            if len(best) == 1:  # one surviving boundary: all before it is settled
                yield from self.path(back, at, base)
                text, base, back = text[at - base :], at, {}
            elif (at - base) % (2 * width) == 0 and (met := self.meeting(best, back, base)) > base:
                yield from self.path(back, met, base)
                text, base, back = text[met - base :], met, {b: v for b, v in back.items() if b > met}
        yield from self.path(back, at, base)

    @staticmethod
    def meeting(best: dict, back: dict, base: int) -> int:
        """The last boundary that the paths of all surviving boundaries share."""
        front = set(best)
        while len(front) > 1:
            top = max(front)
            front.remove(top)
            front.add(back[top][0])
        return max(base, front.pop())

    def path(self, back: dict, end: int, base: int) -> list[int]:
        out: list[list[int]] = []
        while end > base:
            end, piece = back[end]
            i = self.pieces.get(piece)
            out.append([i] if i is not None else self.spelled(piece))
        return [i for part in reversed(out) for i in part]

    def stretch(self, text: str) -> list[int]:
        """Ids of what lies between two certain boundaries; pairs found in no piece cut it further."""
        memory, beside = self.memory, self.beside
        if self.kind == "bpe" and len(text) <= 2 * self.longest:
            memory[text] = out = self.window(text)
            return out
        cuts = [0, *(k for k in range(1, len(text)) if text[k - 1 : k + 1] not in beside), len(text)]
        out: list[int] = []
        for a, b in zip(cuts, cuts[1:], strict=False):
            part = text[a:b]
            ids = memory.get(part)
            if ids is None:
                ids = list(self.stream(part))
                if b - a <= 32:
                    memory[part] = ids
            out += ids
        if len(text) <= 32:
            memory[text] = out
        return out

    def encode(self, text: str) -> list[int]:
        """The ids of ``text`` with the leading space mark that the vocabulary expects."""
        if not text:
            return []
        out: list[int] = []
        for k, segment in enumerate(text.split(MARK)):
            if k:
                out += self.spelled(MARK)
            marked = MARK * (k == 0) + segment.replace(" ", MARK)
            if not self.word_breaks:
                out += self.stretch(marked)
                continue
            if len(self.memory) > self.keep:
                self.memory.clear()
            memory = self.memory
            for part in self.parts(marked):
                ids = memory.get(part)
                out += self.stretch(part) if ids is None else ids
        return out

    @staticmethod
    def parts(marked: str):
        """Cut before each run of marks that follows another character."""
        words = marked.split(MARK)
        if "" not in words[1:]:
            if words[0]:
                yield words[0]
            for w in words[1:]:
                yield MARK + w
            return
        start, n, at = 0, len(marked), 0
        while at < n:
            while at < n and marked[at] == MARK:
                at += 1
            at = marked.find(MARK, at)
            if at < 0:
                at = n
            yield marked[start:at]
            start = at

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


_MODELS: dict[str, Viterbi] = {}


def model_of(path: str) -> Viterbi:
    return _MODELS.get(path) or _MODELS.setdefault(path, Viterbi(path))


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ids."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        vocabulary = model_of(model)
        return {id_col: batch.column(0), "ids": [vocabulary.encode(t or "") for t in batch.column(1).to_pylist()]}

    kind = docs.schema[id_col].dataType.simpleString()
    return by_batch(docs.select(F.col(id_col), F.col(text_col).cast("string")), f"`{id_col}` {kind}, ids array<int>", run)


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per input row: id, text."""

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        vocabulary = model_of(model)
        return {id_col: batch.column(0), "text": [vocabulary.decode(x or []) for x in batch.column(1).to_pylist()]}

    kind = encoded.schema[id_col].dataType.simpleString()
    return by_batch(encoded.select(F.col(id_col), F.col(ids_col)), f"`{id_col}` {kind}, text string", run)


def encode_and_check(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_ids, ids_crc32 (little-endian unsigned 32-bit ids), exact (the ids decode to the text)."""
    import numpy as np

    def run(batch: pa.RecordBatch) -> dict[str, list]:
        vocabulary = model_of(model)
        out: dict[str, list] = {"n_ids": [], "ids_crc32": [], "exact": []}
        for text in map(lambda t: t or "", batch.column(1).to_pylist()):
            ids = vocabulary.encode(text)
            out["n_ids"].append(len(ids))
            out["ids_crc32"].append(zlib.crc32(np.asarray(ids, "<u4").tobytes()))
            out["exact"].append(vocabulary.decode(ids) == text)
        return {id_col: batch.column(0)} | out

    kind = docs.schema[id_col].dataType.simpleString()
    return by_batch(docs.select(F.col(id_col), F.col(text_col).cast("string")), f"`{id_col}` {kind}, n_ids long, ids_crc32 long, exact boolean", run)

"""Token sequences packed by hierarchical best fit.

Each document becomes its tokenizer ids and one closing id, cut into pieces of at most ``capacity``. Partitions
pack their own pieces by best fit, largest first, and emit the bins that are nearly full; the underfull bins go on as items to a
round over fewer partitions, until one round sees all that is left or the rounds stop
shrinking. A task never takes more than ITEMS_PER_TASK items on average, however large the input is.
A bin carries its members, at most ``capacity`` of them, so no join is needed to number them.

Defined results: a null or empty text is the closing id alone; repeated rows are packed each on its own;
ids may be null; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import bisect
import re
import struct
import zlib
from collections.abc import Iterator
from operator import methodcaller

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillspan.llm.common import by_batch, durable

ITEMS_PER_TASK = 60_000
#: A bin this full goes no further.
NEARLY_FULL = 0.999
FAN_IN = 8
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
BINS = f"full boolean, used long, members array<struct<{PIECES.replace(' ', ':')}>>".replace(",:", ",")


class WordEncoder:
    """Ids of a lower-casing word BPE, with known stretches remembered.

    The vocabulary never joins across spaces, tabs or line ends, so a text is cut there first. What
    lies between is cut into letter runs, single digits and symbol runs as the tokenizer does, for ASCII and Latin-1; any other
    stretch goes through the tokenizer whole. A Latin-1 text is first lower-cased, and a symbol between a letter and a
    space parted from the letter, so that few stretches differ and most are one word; special tokens, which are told
    by their case, begin with ``<|``, and texts with these signs are left as they are. The memory has a newer and an older
    half of ``keep`` entries each: when the newer one is full, it takes the place of the older one, and what is used
    again comes back from there.
    """

    def __init__(self, path: str, keep: int = 200_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = re.compile(r"[\x21-\x7e\xc0-\xff]+")
        self.cut = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
        self.part = re.compile(r"([!,.:;?])(?<=[a-z\xe0-\xf6\xf8-\xff].)(?=[ \n\t\r])").sub
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in set(shown)]
        self.byte = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.newer: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.keep = keep

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, word: str) -> bytes:
        shown = word if word.isascii() else "".join(map(self.byte.__getitem__, word.encode()))
        return self.pack([t.id for t in self.tokenizer.model.tokenize(shown)])

    def stretch(self, text: str) -> bytes:
        if (got := self.older.get(text)) is not None:
            pass
        elif text.isascii() and text.isalpha():
            got = self.word(text.lower())
        elif "<|" in text or not self.plain.fullmatch(text):
            got = self.pack(self.tokenizer.encode(text, add_special_tokens=False).ids)
        else:
            got = b"".join([self.newer.get(w) or self.older.get(w) or self.word(w) for w in self.cut.findall(text.lower())])
        if len(text) <= 24:
            if len(self.newer) >= self.keep:
                self.newer, self.older = {}, self.newer
            self.newer[text] = got
        return got

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        if "<|" not in text and _latin(text):
            text = self.part(r" \1", text.lower())
        make = self.stretch
        return b"".join([got if (got := self.newer.get(s)) is not None else make(s) for s in text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") if s])


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


_AS_PY = methodcaller("as_py")
_ENCODERS: dict[str, WordEncoder] = {}


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 4096, closing: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    end = closing.to_bytes(4, "little")

    def cut(batch: pa.RecordBatch) -> dict[str, list]:
        encoder = _ENCODERS.get(tokenizer) or _ENCODERS.setdefault(tokenizer, WordEncoder(tokenizer))
        out: dict[str, list] = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for key, text in zip(batch.column(0).to_pylist(), map(_AS_PY, batch.column(1)), strict=True):  # one at a time: a batch of texts is large
            ids = encoder.encode(text or "") + end
            for k, first in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[first : first + 4 * capacity]
                for name, value in zip(out, (key, k, first // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                    out[name].append(value)
        return out

    return by_batch(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")), PIECES, cut)


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of positions, sizes taken largest first, each into the fullest open bin that still takes it."""
    left: list[int] = []  # distinct room sizes of open bins, ascending
    open_bins: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    for at in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[at]
        k = bisect.bisect_left(left, size)
        if k == len(left):
            bins.append([at])
            which, room = len(bins) - 1, capacity - size
        else:
            room = left[k]
            which = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], left[k]
            bins[which].append(at)
            room -= size
        if room:
            if room not in open_bins:
                bisect.insort(left, room)
                open_bins[room] = []
            open_bins[room].append(which)
    return bins


def _round(items: DataFrame, parts: int, capacity: int, salt: int) -> DataFrame:
    """Pack ``items`` (used, members) inside each of ``parts`` partitions."""
    first = F.col("members")[0]
    dealt = items.select("used", "members").repartition(parts, F.xxhash64(first["doc_id"], first["piece"], first["ids_crc32"], F.lit(salt)))
    least = int(capacity * NEARLY_FULL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for b in batches for r in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        # a recomputed task gets its rows in another order: sort by content, so that it packs them alike
        rows.sort(key=lambda r: (-r[0], [(m["doc_id"] is None, m["doc_id"] or 0, m["piece"], m["ids_crc32"]) for m in r[1][:1]]))
        bins = best_fit([r[0] for r in rows], capacity)
        schema = pa.schema([("full", pa.bool_()), ("used", pa.int64()), ("members", pa.list_(MEMBER))])
        for k in range(0, len(bins), 2000):
            used = [sum(rows[i][0] for i in b) for b in bins[k : k + 2000]]
            members = [[m for i in b for m in rows[i][1]] for b in bins[k : k + 2000]]
            yield pa.RecordBatch.from_arrays([pa.array([u >= least for u in used]), pa.array(used, pa.int64()), pa.array(members, pa.list_(MEMBER))], schema=schema)

    return dealt.mapInArrow(run, BINS)


MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def pack(parts: DataFrame, capacity: int = 4096) -> DataFrame:
    """Place pieces: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    names = [x.split()[0] for x in PIECES.split(", ")]
    parts = durable(parts.select(*names))
    whole = parts.where(F.col("length") >= capacity).select(F.array(F.struct(*names)).alias("members"))
    todo = parts.where(F.col("length") < capacity).select(F.col("length").alias("used"), F.array(F.struct(*names)).alias("members"))
    done, left = [whole], todo.count()
    tasks, salt = max(1, -(-left // ITEMS_PER_TASK)), 0
    while left:
        bins = durable(_round(todo, tasks, capacity, salt))
        todo, before = bins.where("not full"), left
        left = todo.count()
        fewer = max(-(-left // ITEMS_PER_TASK), -(-tasks // FAN_IN))
        if tasks == 1 or not left or (fewer >= tasks and left > 0.95 * before):
            done.append(bins.select("members"))
            break
        done.append(bins.where("full").select("members"))
        tasks, salt = min(fewer, tasks), salt + 1
    bins = done[0]
    for other in done[1:]:
        bins = bins.unionByName(other)
    placed = bins.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.posexplode(with_offsets(F.col("members"))))
    return placed.select(*(F.col(f"col.m.{n}").alias(n) for n in names), "sequence_id", F.col("col.offset").alias("offset"))


def with_offsets(members):
    """Array of struct(m, offset): the tokens before each member."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.slice(F.transform(members, lambda m: F.struct(m.alias("m"), F.lit(0).cast("long").alias("offset"))), 1, 0).alias("out"))
    return F.aggregate(
        members,
        zero,
        lambda acc, m: F.struct((acc["at"] + m["length"]).alias("at"), F.concat(acc["out"], F.array(F.struct(m.alias("m"), acc["at"].alias("offset")))).alias("out")),
        lambda acc: acc["out"],
    )


def best_fit_packing(docs: DataFrame, tokenizer: str, capacity: int = 4096, closing: int = 1) -> DataFrame:
    return pack(pieces(docs, tokenizer, capacity, closing), capacity)

"""Byte-level BPE by prefix dynamic programming.

For each prefix of a piece's bytes exactly one token can be the last of the prefix's encoding. It is the token t that ends there,
begins where another prefix ends, and forms a valid pair with that prefix's last token: a pair that the merges, in order of rank,
would not change across the boundary. The table of last tokens gives the encoding of every prefix by walking back, takes further
bytes without looking at the old ones again, and after an edit only entries from the edit on change, until the table is the old one
again for as long as a token can be.

Null and empty texts have no ids. Encoding is by piece of the pattern, as the tokenizer's library does it; no special tokens. Texts of
any length are encoded whole. Repeated rows get equal results, and the encoding of a piece is unique, so ties do not arise. An empty
table gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rows_of, table

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Encodings of pieces in one of the two generations that a task remembers.
REMEMBERED = 500_000


class PrefixBpe:
    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: b for b, r in ranks.items()}
        self.longest = max(map(len, ranks), default=1)
        top = max(ranks.values(), default=0) + 1
        # each token's halves by its own merge, -1 for single bytes; the token that a pair of tokens merges into, by one number
        self.first, self.second = [-1] * top, [-1] * top
        self.joined: dict[int, int] = {}
        self._valid: dict[int, bool] = {}
        for b, r in sorted(ranks.items(), key=lambda x: x[1]):
            for i in range(1, len(b)):
                left, right = ranks.get(b[:i]), ranks.get(b[i:])
                if left is not None and right is not None and left < r and right < r and self._stays(left, right):
                    self.first[r], self.second[r] = left, right
                    self.joined[left << 32 | right] = r
                    break

    def _stays(self, left: int, right: int) -> bool:
        """Whether merging by rank leaves the boundary between the two tokens alone: undo their merges, the latest first, and see that no merge across the boundary comes before the next one inside."""
        across, first, second = self.joined.get, self.first, self.second
        before = 1 << 62  # the rank of the merge that was undone last
        while True:
            if across(left << 32 | right, before) < before:
                return False
            if left > right and second[left] >= 0:
                before, left = left, second[left]
            elif first[right] >= 0:
                before, right = right + 1, first[right]  # at equal rank the left one merges first
            elif second[left] >= 0:
                before, left = left, second[left]
            else:
                return True

    def valid(self, left: int, right: int) -> bool:
        pair = left << 32 | right
        known = self._valid.get(pair)
        if known is None:
            if len(self._valid) > 2_000_000:
                self._valid.clear()
            known = self._valid[pair] = self._stays(left, right)
        return known

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> list[int]:
        """Continue the table of last tokens, one entry for each prefix that has bytes, to the end of data."""
        get, valid, longest = self.ranks.get, self.valid, self.longest
        for end in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            for begin in range(max(0, end - longest), end):
                t = get(data[begin:end])
                if t is not None and (begin == 0 or valid(last[begin - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return last

    def walk_back(self, last: list[int], end: int | None = None) -> list[int]:
        out, at = [], len(last) if end is None else end
        while at:
            out.append(last[at - 1])
            at -= len(self.token[out[-1]])
        return out[::-1]

    @cached_property
    def ends(self):
        """All tokens that end at each byte, from one pass over the bytes; bytes stand as characters."""
        import ahocorasick

        a = ahocorasick.Automaton()
        for b, r in self.ranks.items():
            a.add_word(b.decode("latin-1"), (r, len(b)))
        a.make_automaton()
        return a

    def last_tokens(self, data: bytes) -> list[int]:
        """The table of last tokens of a whole piece."""
        last, known, valid = [-1] * len(data), self._valid.get, self.valid
        for end, (t, n) in self.ends.iter(data.decode("latin-1")):
            if last[end] < 0:
                if n > end:
                    last[end] = t
                else:
                    before = last[end - n]
                    ok = known(before << 32 | t)
                    if ok or ok is None and valid(before, t):
                        last[end] = t
        if -1 in last:
            raise ValueError("the vocabulary lacks a byte")
        return last

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.walk_back(self.last_tokens(piece))

    def edit(self, data: bytes, last: list[int], at: int, removed: int, added: bytes) -> tuple[bytes, list[int]]:
        """The data and table after an edit: entries before it stay, and those after it are taken over once a token's length of them agrees."""
        new, table_ = data[:at] + added + data[at + removed :], last[:at]
        shift, agree = len(added) - removed, 0
        for end in range(at + 1, len(new) + 1):
            self.extend(new, table_, end)
            old = end - shift
            agree = agree + 1 if end > at + len(added) and 0 < old <= len(last) and last[old - 1] == table_[-1] else 0
            if agree >= 2 * self.longest:
                return new, table_ + last[old:]
        return new, table_

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


@lru_cache(maxsize=2)
def load(path: str) -> PrefixBpe:
    with open(path, "rb") as f:
        return PrefixBpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})


def _encoded(vocabulary: str | None, with_ids: bool):
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        import regex

        bpe = load(vocabulary or public_tokenizers.path(VOCABULARY))
        pieces = regex.compile(public_tokenizers.PATTERN).findall

        class Known(dict):
            """Pieces met: their ids as text, the bytes that these decode to, and the ids."""

            older: dict = {}

            def __missing__(self, piece: str) -> tuple[str, bytes, list[int]]:
                found = self.older.pop(piece, None)
                if found is None:
                    ids = bpe.encode(piece.encode("utf-8", "surrogatepass"))
                    found = " ".join([names[i] for i in ids]), bpe.decode(ids), ids
                if len(self) >= REMEMBERED:  # two generations, so that what is frequent is never forgotten
                    self.older = dict(self)
                    self.clear()
                if len(piece) <= 64:
                    self[piece] = found
                return found

        names = [str(i) for i in range(len(bpe.first))]
        known = Known()
        for batch in rows_of(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                said, decoded, ids = zip(*map(known.__getitem__, pieces(text))) if text else ((), (), ())
                row = doc_id, sum(map(len, ids)), hashlib.sha256(" ".join(said).encode()).hexdigest(), hashlib.sha256(b"".join(decoded)).hexdigest()
                out.append((*row, [i for x in ids for i in x]) if with_ids else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    return run


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, the ids. vocabulary: a rank file's path on the executors."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(_encoded(vocabulary, with_ids), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
    return out.withColumnRenamed("doc_id", id_col)


def op5_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), with_ids=False)

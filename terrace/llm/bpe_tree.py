"""Byte-level BPE by a tree of halves, each pair of neighbours joined at the seam.

A text is halved down to leaves. A node holds the ids of its stretch of text. Two neighbours are
joined by encoding anew the text between two safe points, one on each side of the seam:

* A safe point lies before white space that follows another character, or where a run of letters or
  of digits ends. The pattern has no look-behind and none of its matches crosses such a point, so
  ids before the left point and behind the right one are the same in the joined text. The window
  around the seam grows until it has such points or reaches the ends.
* Where the window is one long match, its halves are encoded by the same tree and joined on ids: the
  window of ids around the seam is encoded anew and grows until each pair of ids at its rims
  encodes to itself. All neighbouring pairs then do, and only the encoding has that property.

Decoding joins the bytes of the ids up the same tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from terrace.llm.common import Encoder, text_of

#: Characters of a leaf, and of the first window on each side of a seam.
LEAF, WINDOW = 64, 16
_POINT = r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})"
#: The first safe point of a stretch, and the last one.
_SAFE, _LAST_SAFE = regex.compile(_POINT), regex.compile(f"(?r){_POINT}")


def multi_vocabulary() -> dict:
    import public_tokenizers as P

    return {"path": P.path("byte_bpe_multi_50k.tiktoken"), "pattern": P.PATTERN, "special": ()}


class Tree:
    """Encodes and decodes single texts."""

    def __init__(self, encoder: Encoder, leaf: int = LEAF, window: int = WINDOW):
        self.encoder, self.leaf, self.window = encoder, leaf, window
        self.bytes_of = [b""] * (max(encoder.ranks.values()) + 1)
        for value, rank in encoder.ranks.items():
            self.bytes_of[rank] = value
        self.sizes = list(map(len, self.bytes_of))
        self.matches = regex.compile(encoder.exact._pat_str)

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text; empty for an empty one."""
        return self._node(text, 0, len(text), self.encoder.for_parts(text))

    def _node(self, text: str, start: int, end: int, ids_of: Callable[[str], list[int]]) -> list[int]:
        if end - start <= self.leaf:
            return ids_of(text[start:end])
        middle = (start + end) // 2
        return self._join(text, start, middle, end, self._node(text, start, middle, ids_of), self._node(text, middle, end, ids_of), ids_of)

    def _join(self, text: str, start: int, middle: int, end: int, left: list[int], right: list[int], ids_of: Callable[[str], list[int]]) -> list[int]:
        """The ids of both parts; ``left`` is taken over."""
        a, b = self._safe_left(text, start, middle), self._safe_right(text, middle, end)
        sizes, keep, drop = self.sizes, len(left), 0
        size = len(text[a:middle].encode())
        while size > 0:
            keep -= 1
            size -= sizes[left[keep]]
        rest = len(text[middle:b].encode())
        while rest > 0:
            rest -= sizes[right[drop]]
            drop += 1
        assert size == rest == 0, "a safe point lies inside an id"
        # The window is read up to the next safe point, so its last match cannot look beyond it.
        left[keep:] = self._window(text[a:b], ids_of)
        left += right[drop:]
        return left

    def _safe_left(self, text: str, start: int, middle: int) -> int:
        width = self.window
        while True:
            low = max(start, middle - width)
            # A space behind a character that is none is the commonest safe point, and the quickest to find.
            at = text.rfind(" ", low + 1, middle - 1)
            if at > 0 and not text[at - 1].isspace():
                return at
            found = _LAST_SAFE.search(text, low, middle - 1)
            if found and found.start() > low:
                return found.start()
            if low == start:
                return start
            width *= 2

    def _safe_right(self, text: str, middle: int, end: int) -> int:
        width = self.window
        while True:
            high = min(end, middle + width)
            at = text.find(" ", middle + 2, high)
            if at > 0 and not text[at - 1].isspace():
                return at
            found = _SAFE.search(text, middle + 2, high)
            if found:
                return found.start()
            if high == end:
                return end
            width *= 2

    def _window(self, text: str, ids_of: Callable[[str], list[int]]) -> list[int]:
        if len(text) <= max(self.leaf, 4 * self.window):
            return ids_of(text)
        out: list[int] = []
        for match in self.matches.findall(text):
            out += self._piece(match.encode()) if len(match) > self.leaf else self.encoder.exact._encode_single_piece(match.encode())
        return out

    def _piece(self, data: bytes) -> list[int]:
        """Ids of one match, whatever its length."""
        if len(data) <= self.leaf:
            return self.encoder.exact._encode_single_piece(data)
        middle = len(data) // 2
        left, right, k = self._piece(data[:middle]), self._piece(data[middle:]), 1
        while True:
            a, b = max(0, len(left) - k), min(len(right), k)
            joined = self._ids_of(left[a:] + right[:b])
            if (a == 0 or self._apart(left[a - 1], joined[0])) and (b == len(right) or self._apart(joined[-1], right[b])):
                return left[:a] + joined + right[b:]
            k *= 2

    def _ids_of(self, ids: list[int]) -> list[int]:
        return self.encoder.exact._encode_single_piece(b"".join(map(self.bytes_of.__getitem__, ids)))

    def _apart(self, a: int, b: int) -> bool:
        return self._ids_of([a, b]) == [a, b]

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of ids, joined pairwise up the tree."""
        leaf = self.leaf
        level = [b"".join([self.bytes_of[i] for i in ids[k:k + leaf]]) for k in range(0, len(ids), leaf)] or [b""]
        while len(level) > 1:
            level = [b"".join(level[k:k + 2]) for k in range(0, len(level), 2)]
        return level[0]


def encode_decode(docs: DataFrame, text: str = "text", ids: tuple[str, ...] = ("doc_id",), vocabulary: dict | None = None,
                  full: bool = False, leaf: int = LEAF) -> DataFrame:
    """Encode each text, decode the ids, and return ``ids`` with ``n_tokens`` and two digests.

    ``ids_sha256`` is over the decimal ids joined by commas, ``decoded_sha256`` over the decoded
    bytes. With ``full`` the columns ``token_ids`` and ``decoded`` (binary) hold both in full. Null
    and empty texts have no ids. Rows are handled one by one, in place: repeated rows and null ids
    stay, other columns are left out, an empty table gives an empty one.
    """
    vocabulary = vocabulary or multi_vocabulary()
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in ids), "n_tokens long, ids_sha256 string, decoded_sha256 string",
                        *(["token_ids array<int>, decoded binary"] if full else [])])
    k = len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(Encoder.of(**vocabulary), leaf)
        decimal = [str(i) for i in range(len(tree.bytes_of))]
        for batch in batches:
            counts, first, second, tokens, decoded = [], [], [], [], []
            for value in batch.column(k).to_pylist():
                got = tree.encode(value)
                back = tree.decode(got)
                counts.append(len(got))
                first.append(hashlib.sha256(",".join([decimal[i] for i in got]).encode()).hexdigest())
                second.append(hashlib.sha256(back).hexdigest())
                if full:
                    tokens.append(got), decoded.append(back)
            columns = [*(batch.column(i) for i in range(k)), pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            names = [*batch.schema.names[:k], "n_tokens", "ids_sha256", "decoded_sha256"]
            if full:
                columns += [pa.array(tokens, pa.list_(pa.int32())), pa.array(decoded, pa.binary())]
                names += ["token_ids", "decoded"]
            yield pa.record_batch(columns, names=names)

    return docs.select(*ids, text_of(docs, text).alias("_text")).mapInArrow(run, schema)
